from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from wirelens.functions.rulepacks import RUSSIAN
from wirelens.operators.classify import add_score, classify, fresh, limit_per_key, minimum_score, rank, rejected_report, stage_counts
from wirelens.operators.policy import judge, vetoes

AT = datetime(2026, 9, 22, 12, 0, tzinfo=timezone.utc)


def items(spark, *titles, description=""):
    return spark.createDataFrame([(i, t, description, None, AT) for i, t in enumerate(titles)], "ordinal int, title string, description string, article_text string, published_at timestamp")


def rows(df):
    return df.orderBy("ordinal").collect()


def test_weak_topics_are_not_admitted(spark):
    found = rows(classify(items(spark, "Полиция задержала подозреваемого", "Суд вынес приговор за кражу", "Мошенники похитили деньги"), RUSSIAN))
    assert not any(r.admitted for r in found)
    assert all(r.rejection_reason for r in found)


def test_hard_topics_are_admitted(spark):
    found = rows(classify(items(spark, "Мужчина убил соседа", "Женщина найдена убитой", "В доме застрелили хозяина", "Раскрыто убийство"), RUSSIAN))
    assert all(r.admitted and r.strong_topics for r in found)
    assert found[0].admission_reason == 'hard serious topic "убил"'


def test_conditional_needs_an_outcome(spark):
    found = rows(classify(items(spark, "Прохожего избили", "Подросток избил прохожего до смерти"), RUSSIAN))
    assert not found[0].admitted
    assert found[1].admitted and found[1].strong_topics == ["избил + до смерти"]
    assert found[1].admission_reason == 'conditional "избил" + severe outcome "до смерти"'


def test_stems_start_words(spark):
    found = rows(classify(items(spark, "Последствия паводка", "Пытался убить"), RUSSIAN))
    assert found[0].matched_topics == [] and found[0].rejection_reason == "no crime topics"
    assert "убит" not in found[1].matched_topics


def test_requested_killing_does_not_count(spark):
    texts = ["Она просила, чтобы её убили", "Она просила, чтобы её убили. В доме убили соседа"]
    found = rows(add_score(classify(items(spark, *texts), RUSSIAN), RUSSIAN))
    assert not found[0].admitted and found[0].score == 0 and len(found[0].ignored_fragments) == 1
    assert found[0].rejection_reason == "requested killing is not a completed homicide"
    assert found[1].admitted and found[1].score >= 10


def test_score_caps_the_bonus(spark):
    text = "убийство: задержан, арест, приговор, следствие, полиция, обвинение, розыск"
    assert rows(add_score(items(spark, text), RUSSIAN))[0].score == 13


def test_rank_keeps_input_order_of_ties(spark):
    df = spark.createDataFrame([(0, 7), (1, 10), (2, 7), (3, 10)], "ordinal int, score int")
    assert [r.ordinal for r in rank(df).collect()] == [1, 3, 0, 2]
    assert [r.ordinal for r in rank(df, 1).collect()] == [1]
    scored = minimum_score(df, 8).orderBy("ordinal").collect()
    assert scored[0].score_rejection == "score 7 below minimum 8" and scored[1].score_passed


def test_background_reason_stays_on_admitted_rows(spark):
    r = rows(classify(items(spark, "Убийство: полиция задержала подозреваемого"), RUSSIAN))[0]
    assert r.admitted and r.rejection_reason.startswith("only contextual topics") and r.effective_rejection_reason is None


def test_figurative_and_excluded(spark):
    found = rows(classify(items(spark, "Сахар — убийца иммунитета", "Фильм про убийство"), RUSSIAN))
    assert [r.rejection_reason for r in found] == ["figurative homicide language", "excluded keyword"]


POLICY = [
    ("Политик раскрыл отношения с убитым лидером страны", "", "political_commentary"),
    ("Канцлер прокомментировал визит: убийца возвращается на место преступления", "", "political_rhetoric"),
    ("МИД выразил протест в связи с убийством туриста", "", "diplomatic_reaction"),
    ("Водитель убил попутчика; МИД выразил протест в связи с убийством", "", None),
    ("На базе ввели запрет на выход военных после убийства женщины", "", "military_crime_response"),
    ("Почти все пленницы подверглись изнасилованию, заявил министр", "", "aggregate_political_statement"),
    ("Убийство в центре: главные новости 5 мая", "Что произошло за сутки. Убит мужчина.", "news_roundup"),
    ("Новости города: убит мужчина", "", None),
    ("Подозреваемый в убийстве ранен при погоне", "Полицейские догнали машину.", "nonfatal_suspect_incident"),
    ("Подозреваемый в убийстве ранен при погоне", "При погоне полицейский погиб.", None),
    ("Медведь убил туриста", "", "animal_event"),
    ("Мужчина убил хозяина собаки", "", None),
    ("Мужчина расстрелял машину соседа", "", "nonfatal_shooting"),
    ("Его обвиняют в покушении на убийство", "", "standalone_attempt"),
    ("Его обвиняют в покушении на убийство, жену он убил", "", None),
    ("В Токио убит бизнесмен", "", "excluded_country"),
    ("В Москве убит гражданин, прибывший из Индии", "", None),
    ("В Швеции мужчина изнасиловал туристку", "", "foreign_rape"),
    ("В Москве мужчина изнасиловал туристку", "", None),
    ("Мужчина изнасиловал туристку", "", None),
    ("В Швеции трое мужчин: двое изнасиловали туристку", "", None),
    ("В Швеции туристку изнасиловали и убили", "", None),
    ("Раскрыто убийство 2010 года", "", "stale_event"),
    ("Убийство мужчины, 1978 года рождения", "", None),
    ("Раскрыто убийство 2026 года", "", None),
    ("Раскрыто убийство двадцатилетней давности", "", "stale_event"),
    ("Убийцу сторожа нашли спустя полтора года", "", "stale_event"),
    ("Женщина убита 5 мая прошлого года", "", "stale_event"),
]


def test_policy_cascade(spark):
    df = spark.createDataFrame([(i, t, "", b, AT) for i, (t, b, _) in enumerate(POLICY)], "ordinal int, title string, description string, article_text string, published_at timestamp")
    found = rows(judge(df))
    wrong = [(p[0], p[2], r.policy_rejection) for p, r in zip(POLICY, found, strict=True) if r.policy_rejection != p[2]]
    assert not wrong
    assert all(r.policy_passed == (r.policy_rejection is None) for r in found)
    assert {r.sexual_violence_location for r in found if "изнасилова" in r.title and r.policy_passed} >= {"foreign", "domestic", "unknown"}


def test_admission_vetoes(spark):
    r = rows(classify(items(spark, "В Токио убит бизнесмен"), RUSSIAN, vetoes()))[0]
    assert not r.admitted and r.rejection_reason.startswith("event took place in an excluded country")


def test_freshness_limits_and_counts(spark):
    now = F.lit(AT)
    df = spark.createDataFrame([(0, "a", AT), (1, "a", None), (2, "b", datetime(2026, 9, 19, 12, 0, tzinfo=timezone.utc)), (3, "b", datetime(2026, 9, 19, 11, 59, tzinfo=timezone.utc)), (4, "b", datetime(2027, 1, 1, tzinfo=timezone.utc))], "ordinal int, source string, published_at timestamp")
    assert [r.ordinal for r in rows(fresh(df, now, 3))] == [0, 2, 4]
    assert [r.ordinal for r in rows(limit_per_key(df, "source", [F.col("ordinal")], 1))] == [0, 2]
    assert limit_per_key(df, "source", [F.col("ordinal")], -1).count() == 0
    flagged = spark.createDataFrame([(True, True), (True, False), (False, True)], "a boolean, b boolean")
    assert stage_counts(flagged, ["a", "b"]).first().asDict() == {"collected": 3, "a": 2, "b": 1}


def test_rejected_report(spark):
    df = add_score(classify(items(spark, "Полиция задержала вора", "Убит мужчина", "Погода"), RUSSIAN), RUSSIAN)
    assert [r.ordinal for r in rejected_report(df).collect()] == [0]


@pytest.mark.parametrize("empty", [0])
def test_empty_input(spark, empty):
    assert judge(add_score(classify(items(spark, "x").limit(empty), RUSSIAN), RUSSIAN)).count() == 0
