"""Validation rules over rows of numbers and narratives, as column expressions.

Every rule is a column of ``array<struct<severity, code, field, message>>``; a row's issues are their concatenation in a
fixed order, so a whole rule set is one projection without Python. Null narratives count as empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .texts import context, spans

NUMBERS = ("age", "career_years", "art_field_primary", "occupation", "province", "employment_type", "has_secondary_job", "individual_art_income_bracket", "has_contract_experience", "has_copyright")

# Vocabularies, patterns and limits that decide which issues a row has.
START_AGE, START_AGE_LATE, LATE_FIELDS = 15, 18, ["사진", "영화", "문학", "기타", "건축"]
PAST_PHASE = r"데뷔|입문|시작|등단|당선|진출|처음|첫\s*(전시|공연|활동|작업)"
OTHER_PERSON = r"^(?:\s*(초반|중반|후반))?(?:의)?\s*(아들|딸|자녀|남편|아내|배우자|부모|어머니|아버지|취향)"
SELF = r"^(?:\s*(초반|중반|후반))?(?:의)?\s*(?:신인|중견|원로|노년|젊은|청년)?\s*(남자|여자|사람|예술인|작가|감독|배우|연주자|창작자|예술가|예능인|화가|판화가|도예가|공예가|사진가|건축가|작곡가|시인|소설가|무용가|안무가|연출가|만화가)|^\s*이상"
NEWCOMER = [r"신진\s*단계", r"신진\s*예술인", r"신진\s*(작가|감독|배우|연주자|창작자|예술가)(?!전)", r"신인\s*(작가|감독|배우|연주자|창작자|예술가)(?!전)", r"새로\s*시작한\s*(작가|감독|배우|연주자|창작자|예술가)"]
VETERAN = ["원로", "중견", "대가", r"수십\s*년", r"오랜\s*세월", r"후배\s*양성", r"제자\s*육성"]
LATE_DEBUT_FIELDS = ("professional_persona", "creative_world_persona", "network_persona", "arts_persona")
LATE_DEBUT_TONE = [r"전통의\s*깊이", r"평생(?:을| 동안)?", r"수십\s*년(?:\s*동안)?", r"오랜\s*세월", r"긴\s*세월", r"젊었을\s*때", r"젊은\s*시절", r"긴\s*경력", r"오랜\s*경력", "원로", "대가", "거장", "한평생", r"오랜\s*시간"]
EARLY_INTEREST = r"어릴\s*적부터|어렸을\s*때부터|어린\s*시절부터"
EDUCATION_CUE = r"고등학교(?:를)?\s*졸업(?:한\s*후|후)?|고졸\s*후|대학교(?:를)?\s*졸업(?:한\s*후|후)?|대학(?:을)?\s*(?:졸업(?:한\s*후|후)?|마치고)|전공"
FIELD_VERB = "시작|활동|진출|전공"
NEGATED_STUDY = r"전공(?:을|이|이라고)?\s*(?:하지\s*않|안\s*했|안\s*하|아니[고였]|이\s*아닌|하지\s*못)|전공(?:을|만)?\s*(?:했|하)\s*(?:으나|지만|음에도)|전공\s*(?:은|이)\s*(?:다른|아니|별도)|(?:다른|별도의?)\s*(?:일|직업|분야)\s*(?:을|를)?\s*(?:하다가|하며|거쳐)"
STATED_AGE, STATED_DECADE = r"(\d{1,2})\s*세\s*(?:무렵|즈음|쯤|경|에|때|부터|이후)", r"(\d{1,2})\s*대(?:\s*(?:초반|중반|후반|들어))?"
GENERAL_TERMS = ["예술", "창작"]
FOREIGN_TERMS = {
    "문학": ["안무", "BIM", "대본 리딩", "도면", "콘티", "녹음실", "오디오 마스터링"],
    "미술": ["대본", "안무", "BIM", "도면 마감", "콘티"],
    "공예": ["대본", "안무", "BIM", "콘티", "롱테이크"],
    "사진": ["대본", "안무", "BIM", "콘티", "악보"],
    "건축": ["대본", "안무", "콘티", "악보", "낭독회"],
    "음악": ["BIM", "콘티", "도면", "안무", "낭독회"],
    "국악": ["BIM", "도면", "콘티", "롱테이크"],
    "대중음악": ["BIM", "도면", "콘티", "낭독회"],
    "방송연예": ["BIM", "도면", "악보 채보", "낭독회"],
    "무용": ["BIM", "도면", "콘티", "악보 채보"],
    "연극": ["BIM", "도면 마감", "콘티"],
    "영화": ["BIM", "도면", "악보 채보", "낭독회"],
    "만화": ["BIM", "도면 마감", "악보", "안무"],
}
# Cues of occupations, any one of which is enough.
ANCHORS = {
    "시인": ["시", "시집"],
    "소설가": ["소설", "소설집", "장편", "단편"],
    "수필가": ["수필", "산문"],
    "평론가": ["평론", "비평"],
    "동화작가": ["동화", "아동문학", "청소년문학"],
    "번역가": ["번역"],
    "회화 작가": ["회화", "미술", "작품"],
    "조각가": ["조각"],
    "판화가": ["판화"],
    "설치미술 작가": ["설치미술", "설치 작업"],
    "미디어아트 작가": ["미디어아트"],
    "도예가": ["도예", "도자"],
    "금속공예가": ["금속공예", "금속 작업"],
    "섬유공예가": ["섬유공예", "직조", "텍스타일"],
    "목공예가": ["목공예", "목재"],
    "유리공예가": ["유리공예", "유리 작업"],
    "다큐멘터리 사진가": ["다큐멘터리 사진", "기록 사진"],
    "파인아트 사진가": ["파인아트 사진", "예술 사진"],
    "광고 사진가": ["광고 사진", "상업 사진"],
    "건축가": ["건축", "설계"],
    "인테리어 디자이너": ["인테리어", "실내 공간"],
    "조경설계가": ["조경", "설계"],
    "작곡가": ["작곡"],
    "지휘자": ["지휘"],
    "성악가": ["성악", "가창"],
    "기악 연주자": ["기악", "연주"],
    "국악인": ["국악"],
    "판소리 명창": ["판소리", "명창", "창"],
    "기악 연주자(국악)": ["국악", "기악", "연주"],
    "싱어송라이터": ["싱어송라이터", "작사", "작곡"],
    "작곡가(대중음악)": ["작곡", "프로듀싱", "대중음악"],
    "세션 연주자": ["세션", "연주"],
    "음악 프로듀서": ["프로듀서", "프로듀싱"],
    "방송 출연자": ["방송 출연", "출연"],
    "예능인": ["예능", "방송", "게스트", "패널", "방송 출연"],
    "방송작가": ["방송작가", "대본", "구성"],
    "MC": ["MC", "진행", "사회"],
    "무용가": ["무용"],
    "안무가": ["안무"],
    "배우": ["배우", "연기"],
    "연출가": ["연출"],
    "극작가": ["극작", "희곡"],
    "무대미술가": ["무대미술", "무대 디자인", "세트"],
    "영화감독": ["영화감독", "영화 감독", "연출"],
    "시나리오 작가": ["시나리오", "각본"],
    "촬영감독": ["촬영감독", "촬영", "카메라"],
    "편집기사": ["편집", "후반작업"],
    "프로듀서": ["프로듀서", "제작"],
    "만화가": ["만화"],
    "웹툰 작가": ["웹툰"],
    "스토리 작가": ["스토리", "서사"],
    "문화예술 매개자": ["매개", "기획", "연결"],
    "예술 행정": ["행정"],
    "융복합 예술가": ["융복합", "복합", "다학제"],
}
PROVINCES = ["서울", "부산", "대구", "인천", "광주", "대전", "울산", "세종", "경기", "강원", "충청북", "충청남", "전북", "전라남", "경상북", "경상남", "제주"]
ELSEWHERE = "기타"
LANDMARKS = {"무등산": "광주", "해운대": "부산", "경복궁": "서울", "창덕궁": "서울"}
EVENT_NAMES = r"서울(?:국제)?(?:영화제|도서전|아트페어|비엔날레|페스티벌)|부산(?:국제)?(?:영화제|비엔날레|아트페어|페스티벌)|광주(?:비엔날레|아트페어|페스티벌)"
FULL_TIME = "전업"
SIDE_JOB = ["겸업", "부업", "아르바이트|알바", "자영업", r"외주\s*(수입|일|업무)", r"원고료\s*외에도"]
LOW_INCOME, HIGH_INCOME = ["없음", "5백만원 미만"], ["5-6천만원 미만", "6천만원 이상"]
RICH = [r"안정적\s*수입", r"전업\s*수입만으로", r"여유\s*있는", "풍족", "고소득", r"많은\s*돈을\s*벌"]
POOR = [r"가족\s*지원에\s*기대", r"부수입\s*없이는", r"생계\s*위협"]
CONTRACT, COPYRIGHT = r"표준계약서|계약서\s*체결", r"저작권\s*수입|인세를\s*받"
BLOCKING = ["AGE_MISMATCH", "EMPLOYMENT_MISMATCH", "OCCUPATION_MISMATCH", "REGION_MISMATCH", "LANDMARK_REGION_MISMATCH", "CAREER_MISMATCH_NEW", "CAREER_MISMATCH_VETERAN", "EMPLOYMENT_DURATION_CONFLATION"]
FEEDBACK_LINES = 8

_ISSUE = "array<struct<severity:string,code:string,field:string,message:string>>"


def none() -> Column:
    return F.array().cast(_ISSUE)


def one(severity: str, code: str, field: Column | str, message: Column) -> Column:
    at = F.lit(field) if isinstance(field, str) else field
    return F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), at.alias("field"), message.alias("message"))


def issue(when: Column, severity: str, code: str, field: str, message: Column) -> Column:
    """One issue where the condition holds; null counts as no."""
    return F.when(when, F.array(one(severity, code, field, message))).otherwise(none())


def unicode(pattern: str) -> str:
    """White space and digits of all scripts."""
    return "(?U)" + pattern


def any_of(patterns: list[str]) -> str:
    return unicode("|".join(f"(?:{p})" for p in patterns))


def narrative(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def joined(names: list[str]) -> Column:
    """Those narratives, a line each."""
    return F.concat_ws("\n", *(narrative(n) for n in names))


def found(text: Column, patterns: list[str]) -> Column:
    """The first match of any of the patterns, empty without one."""
    return F.regexp_extract(text, any_of(patterns), 0)


def says(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("-")) for p in parts))


def debut_age() -> Column:
    """Age less years of activity, a half to the even side; null if either is missing."""
    return F.bround(F.col("age").cast("double") - F.col("career_years").cast("double")).cast("int")


# ---- the rules -----------------------------------------------------------------------------------


def present_self(text: Column, start: Column, length: Column) -> Column:
    """Whether an age at that place is told of oneself and of now."""
    near, after = context(text, start, length, 0, 24), F.substring(text, start + length, F.lit(18))
    return ~F.rlike(after, F.lit(unicode(OTHER_PERSON))) & F.rlike(after, F.lit(unicode(SELF))) & ~F.rlike(near, F.lit(unicode(PAST_PHASE)))


def age_decade(names: list[str]) -> Column:
    """A decade of life told of oneself that the age isn't in: the first one only, by narrative, then by decade."""
    age = F.coalesce(F.col("age").cast("int"), F.lit(0))

    def wrong(text: Column) -> Column:
        def bad(s: Column) -> Column:
            low = F.substring(s["match"], 1, 1).cast("int") * 10
            return present_self(text, s["start"], F.length(s["match"])) & ~age.between(low, low + 9)

        return F.array_min(F.transform(F.filter(spans(text, "[1-9]0대"), bad), lambda s: s["match"]))

    each = F.array(*(F.struct(F.lit(n).alias("field"), wrong(narrative(n)).alias("label")) for n in names))
    first = F.filter(each, lambda x: x["label"].isNotNull())
    return F.transform(F.slice(first, 1, 1), lambda x: one("warning", "AGE_MISMATCH", x["field"], F.concat(x["label"], F.lit(" but age is "), age.cast("string"))))


def career_start(names: list[str]) -> Column:
    """More years of activity than the age allows."""
    start = F.when(F.col("art_field_primary").isin(LATE_FIELDS), START_AGE_LATE).otherwise(START_AGE)
    most = F.greatest(F.col("age").cast("int") - start, F.lit(0))
    return issue(F.col("age").isNotNull() & (F.col("career_years").cast("int") > most), "error", "AGE_CAREER_IMPOSSIBLE", "quant", says(F.col("career_years"), " years at age ", F.col("age"), ", start at ", start))


def late_debut(names: list[str]) -> Column:
    """Every phrase of a long career, of those who began at fifty or later; by narrative, then by phrase."""
    def hits(n: str) -> Column:
        every = F.flatten(F.array(*(F.regexp_extract_all(narrative(n), F.lit(unicode(p)), F.lit(0)) for p in LATE_DEBUT_TONE)))
        return F.transform(every, lambda m: one("warning", "LATE_DEBUT_TONE_MISMATCH", n, F.concat(m, F.lit(" but debut at "), debut_age().cast("string"))))

    fields = [n for n in LATE_DEBUT_FIELDS if n in names]
    return F.when(debut_age() >= 50, F.flatten(F.array(*map(hits, fields)))).otherwise(none()) if fields else none()


def sentence_rest(text: Column, start: Column, most: int) -> Column:
    """From a place to the end of its sentence, at most so many characters."""
    return F.regexp_extract(F.substring(text, start, F.lit(most)), r"(?s)^[^.!?。\n]*[.!?。\n]?", 0)


def states_debut(window: Column) -> Column:
    """A stated age within three years of the debut, or a decade within ten."""
    ages = F.regexp_extract_all(window, F.lit(unicode(STATED_AGE)), F.lit(1))
    decades = F.regexp_extract_all(window, F.lit(unicode(STATED_DECADE)), F.lit(1))
    target = F.floor(debut_age() / 10) * 10
    return F.exists(ages, lambda x: F.abs(x.cast("int") - debut_age()) <= 3) | F.exists(decades, lambda x: F.abs(x.cast("int") - target) <= 10)


def background(names: list[str]) -> Column:
    """Early interest or schooling told in one sentence with the field, of those who began at forty or later."""
    if "cultural_background" not in names:
        return none()
    text, own = narrative("cultural_background"), F.trim(F.coalesce("art_field_primary", F.lit("")))
    names_field = lambda x: F.exists(F.array(own, *map(F.lit, GENERAL_TERMS)), lambda t: (t != "") & F.contains(x, t))
    excused = lambda x: states_debut(x) | F.rlike(x, F.lit(unicode(NEGATED_STUDY)))
    early = found(text, [EARLY_INTEREST])
    at = F.instr(text, early)
    first = (debut_age() >= 40) & (early != "") & names_field(sentence_rest(text, at, 80)) & ~excused(sentence_rest(text, at, 160))
    conflict = lambda x: F.rlike(x, F.lit(unicode(EDUCATION_CUE))) & F.rlike(x, F.lit(FIELD_VERB)) & names_field(x) & ~excused(x)
    second = (debut_age() >= 40) & F.exists(F.split(text, unicode(r"(?<=[.!?。])\s+|\n+")), conflict)
    return F.concat(
        issue(first, "warning", "EARLY_INTEREST_VS_LATE_DEBUT", "cultural_background", says(early, " but debut at ", debut_age())),
        issue(second, "warning", "EDUCATION_DEBUT_TIMELINE_MISMATCH", "cultural_background", says("schooling and field in a sentence but debut at ", debut_age())),
    )


def career_stage(names: list[str]) -> Column:
    """Newcomers of five years and more; veterans of seven and fewer, unless a late debut already tells of it."""
    years, text = F.coalesce(F.col("career_years").cast("int"), F.lit(0)), joined(names)
    new, old = found(text, NEWCOMER), found(text, VETERAN)
    return F.concat(
        issue((years >= 5) & (new != ""), "warning", "CAREER_MISMATCH_NEW", "narrative", says(new, " at ", years, " years")),
        issue((years <= 7) & (old != "") & (F.size(late_debut(names)) == 0), "warning", "CAREER_MISMATCH_VETERAN", "narrative", says(old, " at ", years, " years")),
    )


def employment_duration(names: list[str]) -> Column:
    """The years of activity told as years of the present kind of employment."""
    years = F.col("career_years").cast("int").cast("string")
    # fixed values: the patterns before and behind the number
    pattern = F.concat(F.lit("(?U)"), years, F.lit(r"\s*년(?:간)?\s*(?:동안\s*)?(?:전업|겸업)|(?:전업|겸업)\s*(?:으로서|으로|상태로)?\s*"), years, F.lit(r"\s*년"))
    return issue((F.col("career_years") > 0) & F.rlike(joined(names), pattern), "warning", "EMPLOYMENT_DURATION_CONFLATION", "narrative", says(years, " years of activity told as employment"))


def foreign_terms(names: list[str]) -> Column:
    """An issue for each term of another field."""
    terms = reduce(lambda out, kv: F.when(F.col("art_field_primary") == kv[0], F.array(*map(F.lit, kv[1]))).otherwise(out), FOREIGN_TERMS.items(), F.array().cast("array<string>"))
    text = joined(names)
    return F.transform(F.filter(terms, lambda t: F.contains(text, t)), lambda t: one("error", "FIELD_FOREIGN_VOCAB", "narrative", t))


def occupation(names: list[str], anchors: dict[str, list[str]]) -> Column:
    """None of an occupation's cues in the two narratives that must have one; unknown occupations pass."""
    text = joined([n for n in ("persona", "professional_persona") if n in names])
    cues = F.try_element_at(F.create_map(*(x for k, v in anchors.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), F.col("occupation"))
    lacks = cues.isNotNull() & F.rlike(text, F.lit("[^\n]")) & ~F.exists(cues, lambda c: F.contains(text, c))
    return issue(lacks, "warning", "OCCUPATION_MISMATCH", "professional_persona", says("no cue of ", F.col("occupation")))


def region(names: list[str]) -> Column:
    """The first other province named outside of event names, and the first landmark of another one."""
    text, home = joined([n for n in ("persona", "professional_persona", "living_persona") if n in names]), F.coalesce("province", F.lit(""))
    plain = F.regexp_replace(text, EVENT_NAMES, "")
    other = F.get(F.filter(F.array(*map(F.lit, PROVINCES)), lambda p: F.contains(plain, p) & (p != home)), F.lit(0))
    marks = F.array(*(F.struct(F.lit(k).alias("mark"), F.lit(v).alias("home")) for k, v in LANDMARKS.items()))
    away = F.get(F.filter(marks, lambda m: F.contains(text, m["mark"]) & (m["home"] != home)), F.lit(0))["mark"]
    return F.concat(
        issue((home != "") & other.isNotNull(), "warning", "REGION_MISMATCH", "narrative", says(home, " but ", other)),
        issue((home != "") & away.isNotNull(), "warning", "LANDMARK_REGION_MISMATCH", "narrative", says(home, " but ", away)),
    )


def employment(names: list[str]) -> Column:
    hit = found(joined(names), SIDE_JOB)
    return issue((F.col("employment_type") == FULL_TIME) & ~F.coalesce("has_secondary_job", F.lit(False)) & (hit != ""), "warning", "EMPLOYMENT_MISMATCH", "narrative", says("full-time but ", hit))


def income(names: list[str]) -> Column:
    if "living_persona" not in names:
        return none()
    text, bracket = narrative("living_persona"), F.col("individual_art_income_bracket")
    rich, poor = found(text, RICH), found(text, POOR)
    return F.concat(
        issue(bracket.isin(LOW_INCOME) & (rich != ""), "error", "INCOME_RICH_BUT_LOW", "living_persona", says(bracket, " but ", rich)),
        issue(bracket.isin(HIGH_INCOME) & (poor != ""), "warning", "INCOME_POOR_BUT_HIGH", "living_persona", says(bracket, " but ", poor)),
    )


def contract(names: list[str]) -> Column:
    text = joined(names)
    signed, paid = found(text, [CONTRACT]), found(text, [COPYRIGHT])
    return F.concat(
        issue(~F.coalesce("has_contract_experience", F.lit(False)) & (signed != ""), "warning", "CONTRACT_MISMATCH", "narrative", signed),
        issue(~F.coalesce("has_copyright", F.lit(False)) & (paid != ""), "warning", "COPYRIGHT_MISMATCH", "narrative", paid),
    )


RULES: list[Callable[[list[str]], Column]] = [age_decade, career_start, late_debut, background, career_stage, employment_duration, foreign_terms, occupation, region, employment, income, contract]


def issues(names: list[str], anchors: dict[str, list[str]] = ANCHORS) -> Column:
    """All issues of a row, rule by rule; ``anchors`` are the cues of the known occupations.

    The row needs the columns of ``NUMBERS``."""
    return F.flatten(F.array(*(r(names, anchors) if r is occupation else r(names) for r in RULES)))


# ---- what is done with issues --------------------------------------------------------------------


def rejected(found_issues: Column, phrase_hits: Column) -> Column:
    """A row fails by an error or by any phrase hit."""
    return F.exists(found_issues, lambda x: x["severity"] == "error") | (phrase_hits > 0)


def blocking(found_issues: Column, codes: list[str] = BLOCKING) -> Column:
    """The warnings that hold a row up; all of them if no codes are given."""
    return F.filter(found_issues, lambda x: (x["severity"] == "warning") & (x["code"].isin(codes) if codes else F.lit(True)))


def feedback(found_issues: Column, phrase_labels: Column, warnings: bool = True) -> Column:
    """The first lines that a rewrite is told: issues, then phrases."""
    told = F.filter(found_issues, lambda x: x["severity"].isin(["error", "warning"] if warnings else ["error"]))
    lines = F.concat(F.transform(told, lambda x: F.concat_ws(": ", x["code"], x["message"])), F.transform(phrase_labels, lambda p: F.concat(F.lit("CLICHE: "), p)))
    return F.slice(lines, 1, FEEDBACK_LINES)


def fields_to_rewrite(codes: Column, by_code: dict[str, list[str]], every: list[str]) -> Column:
    """Fields of the codes in order, each once; all fields if no code is known."""
    table = F.create_map(*(x for k, v in by_code.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    known = F.array_distinct(F.flatten(F.transform(codes, lambda c: F.coalesce(F.try_element_at(table, c), F.array().cast("array<string>")))))
    return F.when(F.size(known) == 0, F.array(*map(F.lit, every))).otherwise(F.array_intersect(known, F.array(*map(F.lit, every))))
