"""Language detection: short texts, all codes, mixed scripts, and fitting."""

from collections import Counter

from pyspark.sql import functions as F

from plumbline.functions import language as L
from plumbline.operators import checkers as C
from plumbline.plans.queries import SENTENCE_IN

VECTORS = [
    ("The response is English", "en"), ("Desayunamos en McDonald's hoy", "es"), ("Today we visit the Louvre", "en"),
    ("Hello there friend", "en"), ("Bonjour monsieur", "fr"), ("Guten Morgen", "de"), ("I don't know.", "en"), ("Buenos días señor", "es"), ("Obrigado pela ajuda", "pt"),
    ("Grazie mille amico", "it"), ("Dziękuję bardzo panu", "pl"), ("Kiitos paljon avusta", "fi"), ("Asante sana rafiki", "sw"), ("Cảm ơn bạn nhiều", "vi"), ("Большое спасибо друг", "ru"),
    ("Дуже дякую друже", "uk"), ("Благодаря ви много", "bg"), ("شكرا جزيلا لك", "ar"), ("خیلی ممنون دوست عزیز", "fa"), ("آپ کا بہت شکریہ", "ur"), ("आपका बहुत धन्यवाद", "hi"),
    ("तुमचे खूप आभार आहे", "mr"), ("तपाईंलाई धेरै धन्यवाद छ", "ne"), ("La casa es grande", "es"), ("A casa é grande", "pt"), ("La casa è grande", "it"), ("La maison est grande", "fr"),
    ("Das Haus ist groß", "de"), ("The house is big", "en"), ("Talo on iso", "fi"), ("Nyumba ni kubwa", "sw"), ("Dom jest duży", "pl"),
    ("こんにちは世界", "ja"), ("日本語を勉強する", "ja"), ("你好。再见。", "zh"), ("안녕하세요", "ko"), ("שלום לכולם", "he"), ("สวัสดีครับ", "th"), ("Καλημέρα", "el"),
    ("The word 你好 means hello", "en"), ("Он сказал OK и ушёл домой", "ru"),
    ("", None), ("123 !!", None), ("🎉 …", None), (None, None),
]


def detected(spark, texts, model=None):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(L.detect_language(F.col("t"), model).alias("got")).collect()
    return [r.got for r in rows]


def test_vectors(spark):
    got = detected(spark, [t for t, _ in VECTORS])
    assert [(t, g) for (t, _), g in zip(VECTORS, got)] == VECTORS


def test_every_code(spark):
    assert set(SENTENCE_IN) == set(L.LANGUAGES) and len(L.LANGUAGES) == 31
    assert dict(zip(SENTENCE_IN, detected(spark, list(SENTENCE_IN.values())))) == {k: k for k in SENTENCE_IN}


def test_in_checks(spark):
    rows = [("DON'T PANIC NOW", True, False), ("I KNOW WHERE YOU ARE", True, False), ("JE NE SAIS PAS OÙ TU ES", False, False), ("i know where you are", False, True), ("ich weiß nicht wo du bist", False, False), ("123", False, False)]
    df = spark.createDataFrame(rows, "t string, upper boolean, lower boolean")
    got = df.select(C.english_capital(F.col("t")).alias("u"), C.english_lowercase(F.col("t")).alias("l"), "upper", "lower").collect()
    assert [(r.u, r.l) for r in got] == [(r.upper, r.lower) for r in got]


def test_features(spark):
    texts = ["Ça va? Ok, l'été", "", "a", "x1y  ZZ", "हिन्दी भाषा"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(L.features(F.col("t")).alias("x")).collect()
    assert [sorted(r.x) for r in got] == [sorted(L.features_of(t)) for t in texts]


def test_fit(spark):
    rows = [(lang, s) for lang in ("en", "de", "ru") for s in L.SEEDS[lang].split(".")] + [("xx", "not a code"), (None, "no code"), ("en", None)]
    model = L.fit(spark.createDataFrame(rows, "lang string, text string"), least=1)
    whole = {s: {lang: Counter(f for own, t in rows if own == lang and t for f in L.features_of(t)) for lang in langs} for s, langs in (("Latin", ("de", "en")), ("Cyrillic", ("ru",)))}
    want = L.fitted(whole)
    assert set(model.groups) == {"Latin", "Cyrillic"}
    assert model.groups["Latin"][0] == ("de", "en")
    assert model.groups["Latin"][1] == want.groups["Latin"][1]
    assert detected(spark, ["Guten Morgen", "Hello there friend", "Привет друг"], model) == ["de", "en", "ru"]


def test_fitted_on_documents(spark, data):
    """A model of one half of the documents tells the languages of the other half."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = L.fit(docs.where("doc_id % 2 = 0"))
    ok = docs.where("doc_id % 2 = 1").select(F.avg((L.detect_language(F.col("text"), model) == F.col("lang")).cast("int")).alias("a")).first().a
    assert ok > 0.97


def test_accuracy_on_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert docs.select(F.avg((F.coalesce(L.detect_language(F.col("text")), F.lit("")) == F.col("lang")).cast("int")).alias("a")).first().a > 0.98
