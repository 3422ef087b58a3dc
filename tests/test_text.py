from pyspark.sql import functions as F

from ledgerlark.functions import markup as M
from ledgerlark.functions import text as T
from ledgerlark.operators import extraction as X


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr).first()[0]


def test_counts(spark):
    cases = {"1234": 1234, "1,234": 1234, "1 234": 1234, "1 234": 1234, "1.234": 1234, "1.2K": 1200, "12K": 12000, "3M": 3000000, "": 0, None: 0, "k": 0}
    for raw, n in cases.items():
        assert one(spark, T.parse_count("x"), raw) == n, raw


def test_slug_handle_name(spark):
    assert one(spark, T.slug("x"), "Coût de l'immigration !") == "cout-de-l-immigration"
    assert one(spark, T.slug("x"), "") == "x" and one(spark, T.slug("x"), None) == "x"
    assert one(spark, T.clean_handle("x"), " @Jean ") == "Jean"
    assert one(spark, T.clean_handle("x"), "X") is None and one(spark, T.clean_handle("x"), "à confirmer") is None
    assert one(spark, T.normalize_name("x"), "Mme Éléonore d'Août-Brie") == "eleonore d aout brie"


def test_guid_is_equal_across_forms(spark):
    df = spark.createDataFrame([("U", "https://m/U/status/9#m"), ("u", "https://x.com/u/status/9")], "h string, u string")
    assert df.select(T.post_guid("h", "u").alias("g")).distinct().count() == 1


def test_html(spark):
    assert one(spark, T.clean_html("x"), "<p>Bonjour&nbsp;<b>monde</b></p>") == "Bonjour monde"
    assert one(spark, M.unescape_all("x"), "aujourd&#8217;hui &eacute;") == "aujourd’hui é"
    assert one(spark, T.unaccent("x"), "ÉLÉPHANT… ﬁn") == "elephant... fin"
    assert one(spark, M.unaccent_exact("x"), "ÉLÉPHANT…") == "elephant..."
    doc = '<meta content="T" property="og:title"><h1>H</h1><a href="/a">x</a><a href="/a">y</a>'
    assert one(spark, M.title("x"), doc) == "T"
    assert one(spark, M.links("x"), doc) == ["/a"]
    ld = '<script type="application/ld+json">{"@type":"NewsArticle","headline":"H","author":{"name":"A"}}</script>'
    assert one(spark, M.article_json_ld("x"), ld)["headline"] == "H"
    assert one(spark, M.author("x"), ld) == "A"


def test_urls(spark):
    df = spark.createDataFrame([("https://a.fr/b/c", x) for x in ("http://z", "//h/x", "/r", "d")], "b string, l string")
    assert [r[0] for r in df.select(M.absolute_url("b", "l")).collect()] == ["http://z", "https://h/x", "https://a.fr/r", "https://a.fr/b/d"]
    assert one(spark, T.is_premium("x"), "https://www.lemonde.fr/a") and not one(spark, T.is_premium("x"), "https://exemple.fr")
    assert one(spark, T.archive_target(F.lit("x"), F.col("x")), "https://m.example/u/status/1") == "https://x.com/u/status/1"
    assert one(spark, T.archive_target(F.lit("x"), F.col("x")), "https://m.example/u") == "https://m.example/u"


def test_gates(spark):
    assert not one(spark, T.worth_segmenting("x"), "https://x.y/z Merci !")
    assert one(spark, T.worth_segmenting("x"), "Nous voulons une vraie réforme maintenant")
    for noise in ("Image", "RT by @x: Image", "https://t.co/a", "@a 😀"):
        assert not one(spark, T.classifiable("x"), noise)
    assert one(spark, T.classifiable("x"), "Il faut baisser les impôts")


def test_verbatim(spark):
    df = lambda v, s: spark.createDataFrame([(v, s)], "v string, s string").select(T.verbatim_in_source("v", "s")).first()[0]
    src = "Il a dit : « l’immigration coûte 40 milliards » hier."
    assert df("l'immigration coute 40 milliards", src) and not df("l'immigration coute 50 milliards", src) and not df("court", src)


def test_clean_article(spark):
    text = "Titre\nLire aussi : autre\n5 min de lecture\nVoir [le lien](http://a.b) ici\nPhrase.\n\nPhrase.\nPartager sur Facebook\n\n\n\nFin a@b.fr"
    assert one(spark, X.clean_article("x"), text) == "Titre\nVoir le lien ici\nPhrase.\n\nFin"
    assert one(spark, X.clean_article("x"), None) == ""
    long_ = "Ce long paragraphe explique comment partager l'article avec ses amis sans rien perdre du tout"
    assert one(spark, X.clean_article("x"), long_) == long_


def test_completeness(spark):
    words = "mot " * 600
    assert one(spark, X.completeness_score("x"), words) == 1.0
    assert one(spark, X.completeness_score("x"), words + "premium abonnez-vous") == 0.5
    assert one(spark, X.completeness_score("x"), words + "...") == 0.7
    assert one(spark, X.completeness_score("x"), None) == 0.0
    assert one(spark, X.completeness_reason("x"), "mot") == "word_count_too_low:1<150"
    assert one(spark, X.completeness_reason("x"), words) == "complete"
    assert one(spark, X.completeness_reason("x"), "") == "empty_content"
    assert one(spark, X.press_walled("x"), "Il vous reste 80 % à lire")
    assert one(spark, X.extraction("x", F.lit("m")), "Marine Le Pen " * 80)["is_full"]
    assert one(spark, X.extraction("x", F.lit("m")), None) is None
    assert one(spark, X.looks_walled("x"), "court") and not one(spark, X.looks_walled("x"), "mot " * 250)


def test_fragments_and_language(spark):
    df = spark.createDataFrame([(["a b c d e", "a b c d e f", "z y"],)], "f array<string>")
    assert df.select(T.merge_fragments("f")).first()[0] == "a b c d e\n\nz y"
    assert one(spark, T.script_language("x"), "привет мир") == "ru" and one(spark, T.script_language("x"), "hello") == "en" and one(spark, T.script_language("x"), "") is None
    assert one(spark, T.truncate_words("x", 2), "a b c") == "a b..."
